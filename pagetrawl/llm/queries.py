"""The registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.llm import conversation_repair, decontaminate, merkle, near_dedup, near_vectors, packing, pii, quality, quality_rules, site_style, suffix_dedup, token_files, toxicity
from pagetrawl.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in all documents: counts and spans."""
    found = pii.pii_spans(table(spark, d, "documents").select("doc_id", "text"))

    def of(*kinds):
        return F.filter("pii", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    digest = F.sha2(pii.joined(of(*pii.BASE)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.joined(F.col("pii")).alias("spans"))


def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, a row a piece."""
    pieces = packing.pack(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of all documents."""
    return quality.quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near-duplicates among all documents."""
    return near_dedup.near_duplicates(table(spark, d, "documents"))


def op5_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of all documents that no earlier passage of 100 bytes covers."""
    found = suffix_dedup.without_repeats(table(spark, d, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.contaminated(decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")))


def op7_main_text(spark: SparkSession, d: str) -> DataFrame:
    """Main text of all pages."""
    return site_style.main_text(table(spark, d, "pages"))


def op8_near_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near-duplicates among all vectors of each label."""
    return near_vectors.near_vectors(table(spark, d, "embeddings"))


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_token_files(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all documents, from the files they were written to."""
    return token_files.token_files(table(spark, d, "documents"), vocabulary("word_bpe_49k.json")).drop("file")


#: Fixed values of the contract: the upper-case letters that tampering lowers, and the fields of a leaf.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle(spark: SparkSession, d: str) -> DataFrame:
    """A Merkle manifest of all documents, with the proof of each and its check after tampering."""
    docs = table(spark, d, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF_FIELDS]
    tamper = F.when(hit, merkle.leaf_digest(*lowered))
    found = merkle.manifest(docs, "doc_id", "source", LEAF_FIELDS, tamper)
    return found.proofs.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("group").alias("source")
    )


def op12_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Base quality counts of all documents and the verdict of robust outliers per language and source."""
    return quality_rules.quality_rules(table(spark, d, "documents"))


def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    """Damaged conversations, their faults and the cheapest repair of their structure."""
    found = conversation_repair.repair(table(spark, d, "conversations"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_rows", "most_live")


QUERIES = {"op1_pii": op1_pii, "op2_packing": op2_packing, "op3_quality": op3_quality, "op4_near_dedup": op4_near_dedup, "op5_suffix_dedup": op5_suffix_dedup, "op6_decontaminate": op6_decontaminate, "op7_main_text": op7_main_text, "op8_near_vectors": op8_near_vectors, "op9_toxicity": op9_toxicity, "op10_token_files": op10_token_files, "op11_merkle": op11_merkle, "op12_quality_rules": op12_quality_rules, "op13_conversation_repair": op13_conversation_repair}
ORACLE: dict[str, str] = {}
