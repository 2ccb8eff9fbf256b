"""A corpus pipeline of five stages over ``documents``.

Toxic documents go, one document of each group of near-duplicates stays, documents that hold
benchmark items go, personal data is masked, and what is left is packed into sequences. Each
stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and, but for the
last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.llm import decontaminate, near_dedup, packing, pii, toxicity
from pagetrawl.llm.common import table
from pagetrawl.llm.queries import vocabulary
from pagetrawl.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; texts are read once, nothing is shuffled."""
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; rows without an id stay."""
    found = near_dedup.near_duplicates(docs)
    gone = settle(found.where(~F.col("kept")).select("doc_id"), "near-copies")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; texts are read once, nothing is shuffled."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data masked, and their new lengths."""
    found = pii.pii_spans(docs.select(*COLUMNS))
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col("pii")))
    length = F.when(F.size("pii") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 1024 ids."""
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained scores, edit distances and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of ``documents``; what a stage keeps is settled for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
