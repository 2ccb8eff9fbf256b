"""What the trained classifiers share: a bounded labelled sample, calibration and the scoring pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.llm.common import held_out, release, slices, strings
from pagetrawl.session import text_batches


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def calibration(best: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve through the scores of documents, by Newton's method."""
    middle, spread = best.mean(), best.std() + 1e-6
    x = np.stack([(best - middle) / spread, np.ones_like(best)], axis=1)
    beta = np.zeros(2)
    for _ in range(25):
        p = sigmoid(np.clip(x @ beta, -30, 30))
        slope = x.T @ (p - y) + 0.01 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        beta -= np.linalg.solve(curve, slope)
    return float(beta[0] / spread), float(beta[1] - beta[0] * middle / spread)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int):
    """At most ``per_class`` labelled rows of either class that are not held out, as two lists.

    The rows of the smallest hashes of their ids are taken, whatever the order of the input.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("goal")).where(~held_out())
    chosen = None
    for goal in (0, 1):
        some = known.where(F.col("goal") == goal).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "text"])
    return found["text"].tolist(), found["goal"].tolist()


def score_texts(docs: DataFrame, score, held: int = 256) -> DataFrame:
    """doc_id and score of every row of ``docs``; ``score`` takes a list of texts, at most ``held`` at once."""

    def run(batches):
        release()
        for batch in slices(batches, held, 1):
            scores = np.asarray(score(strings(batch.column(1))), float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def only(docs: DataFrame, choose, held: int = 256) -> DataFrame:
    """The rows of ``docs`` whose texts are chosen, all columns as they are; ``choose`` turns texts into booleans."""
    at = docs.columns.index("text")

    def run(batches):
        release()
        for batch in slices(batches, held, at):
            yield batch.filter(pa.array(np.asarray(choose(strings(batch.column(at))), bool)))

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
