"""Near-duplicates of vectors by iterative quantisation (operator 8).

Rotations are learned on a bounded sample: principal axes, then turns between the best rotation for
the signs and the signs of the rotated vectors, which leaves balanced bits near their
coordinates. A vector's code is the signs of all rotations, each cut into chunks of a few bits, and
each chunk is a hash table. Every vector is entered into every table.

Vectors that share a bucket of a table meet in a self join on (label, bucket); the join keeps a
pair in the first table that it shares and only up to a Hamming distance of the whole codes. The
original vectors then decide in double precision.

Equal vectors are one class and join once. With the angle of cosine 0.93 a bit differs in 12 %
of the cases, so that a chunk of 12 bits agrees in 22 % and all 60 tables miss a pair in about 5 of
10 million. Signs are taken about the origin, not the mean, so that this holds for any mean.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.llm.common import slices
from pagetrawl.llm.graph import components
from pagetrawl.session import settle

LEAST_COSINE = 0.93
CHUNK_BITS, TABLES = 12, 60
#: Codes that differ in more than this share of their bits are not compared; 12 % are expected at the threshold.
#: Only codes of at least ``CHUNK_BITS`` bits a rotation are cut so: shorter codes (vectors of fewer dimensions)
#: have rotations too alike for the share to be a fair count, and all their candidates are compared.
MOST_BITS = 0.33
SAMPLE = 20_000


class Codes:
    """Learned rotations and the codes by them: a 64-bit number a rotation, ``chunks`` tables in each."""

    def __init__(self, sample: np.ndarray, rounds: int = 30, seed: int = 11):
        draw, dim = np.random.default_rng(seed), sample.shape[1]
        bits = min(dim, 60)
        self.bits = max(bits - bits % CHUNK_BITS, min(bits, CHUNK_BITS))
        self.chunks = max(1, self.bits // CHUNK_BITS)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1][:, : self.bits]
        flat, self.rotations = unit @ axes, []
        for _ in range(-(-TABLES // self.chunks)):
            turn = np.linalg.qr(draw.standard_normal((self.bits, self.bits)))[0]
            for _ in range(rounds):
                signs = np.where(flat @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(flat.T @ signs)
                turn = u @ v
            self.rotations.append(axes @ turn)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of one number per rotation for each vector."""
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return np.stack([((vectors @ r) >= 0) @ weights for r in self.rotations], axis=1)

    def buckets(self, codes: np.ndarray) -> np.ndarray:
        """A row of bucket numbers, one a table; the table's number is part of it."""
        width = min(self.bits, CHUNK_BITS)
        parts = [(codes[:, r] >> (width * c)) & ((1 << width) - 1) for r in range(codes.shape[1]) for c in range(self.chunks)]
        return np.stack([(t << width) | p for t, p in enumerate(parts)], axis=1).astype(np.int64)


def usable(vector: str = "embedding"):
    """Vectors that can be linked: neither null nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _coded(vectors: DataFrame, codes: Codes) -> DataFrame:
    n = len(codes.rotations)

    def run(batches):
        for batch in slices(batches, 4096):
            if batch.num_rows:
                found = codes.of(_numbers(batch.column(2)))
                buckets = codes.buckets(found)
                offsets = np.arange(len(found) + 1, dtype=np.int32) * buckets.shape[1]
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), listed, *map(pa.array, np.ascontiguousarray(found.T))],
                    ["vec_id", "label", "buckets", *(f"c{k}" for k in range(n))],
                )

    schema = "vec_id long, label long, buckets array<long>, " + ", ".join(f"c{k} long" for k in range(n))
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, schema)


def _close(batches):
    for batch in slices(batches, 8192):
        if not batch.num_rows:
            continue
        x, y = _numbers(batch.column(2)), _numbers(batch.column(3))
        cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        keep = pa.array(cosine >= LEAST_COSINE)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])


def close_pairs(vectors: DataFrame, codes: Codes) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ``vectors (vec_id, label, vector)`` with the least cosine, each once."""
    n, width = len(codes.rotations), min(codes.bits, CHUNK_BITS)
    coded = settle(_coded(vectors, codes), "codes")
    entered = coded.select("label", F.explode("buckets").alias("bucket"), "vec_id", *(f"c{k}" for k in range(n)))
    other = entered.select("label", "bucket", F.col("vec_id").alias("b"), *(F.col(f"c{k}").alias(f"d{k}") for k in range(n)))
    differ = [F.col(f"c{k}").bitwiseXOR(F.col(f"d{k}")) for k in range(n)]
    distance = reduce(lambda x, y: x + y, [F.bit_count(x) for x in differ])
    mask = (1 << width) - 1
    first = F.coalesce(
        *[F.when(differ[r].bitwiseAND(F.lit(mask << (width * c))) == 0, F.lit(r * codes.chunks + c)) for r in range(n) for c in range(codes.chunks)]
    )
    near = distance <= int(MOST_BITS * codes.bits * n) if codes.bits >= CHUNK_BITS else F.lit(True)
    pairs = (
        entered.join(other, ["label", "bucket"])
        .where((F.col("vec_id") < F.col("b")) & near)
        .where(first == F.shiftright("bucket", width))
        .select(F.col("vec_id").alias("a"), "b")
    )
    mine = vectors.select(F.col("vec_id").alias("a"), F.col("vector").alias("x"))
    theirs = vectors.select(F.col("vec_id").alias("b"), F.col("vector").alias("y"))
    return pairs.join(mine, "a").join(theirs, "b").select("a", "b", "x", "y").mapInArrow(_close, "a long, b long")


def near_vectors(embeddings: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label).

    Rows without a label, and vectors that are null, zero or hold null or non-finite components are linked
    with nothing; so are vectors of different lengths. Equal vectors of one label are linked. The rotations of
    each length are learned on at most ``sample`` distinct vectors; other columns are ignored. Rows of the same
    vec_id get the same component, and each counts as a link of its equals.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable()
    # in units of the largest component, so that squares neither vanish nor overflow
    unit = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    keyed = rows.withColumn("unit", unit)
    keyed = keyed.withColumn("vector", F.when(fine, F.transform("embedding", lambda x: x.cast("double") / F.col("unit") + 0.0)))
    keyed = settle(keyed.select("vec_id", "label", "vector"), "vectors")
    known = keyed.where("vector is not null")
    classes = known.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = settle(classes, "vector-classes")
    reps = classes.select(F.col("rep").alias("vec_id"), "label", "vector", "copies")
    links = None
    for (dim,) in reps.select(F.size("vector")).distinct().collect():
        own = reps.where(F.size("vector") == dim)
        some = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
        found = close_pairs(own, Codes(_numbers(some.column(0).combine_chunks())))
        links = found if links is None else links.unionByName(found)
    if links is None:
        bare = keyed.withColumn("component", F.col("vec_id")).withColumn("n_links", F.lit(0).cast("long"))
    else:
        links = settle(links, "vector-links")
        both = links.union(links.select("b", "a")).toDF("vec_id", "other")
        copies = reps.select(F.col("vec_id").alias("other"), "copies")
        far = both.join(copies, "other").groupBy("vec_id").agg(F.sum("copies").alias("far"))
        component = components(links).withColumnRenamed("id", "vec_id")
        told = reps.join(far, "vec_id", "left").join(component, "vec_id", "left").select(
            "label", "vector", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component"),
        )
        bare = keyed.join(told, ["label", "vector"], "left")
    return bare.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
