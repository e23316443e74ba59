"""Corpus pipeline: stages over documents, each reading what the one before wrote.

Toxic documents go; of each group of near duplicates one stays; documents that leak benchmark items go; secrets are
masked; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common, decontamination, near_dedup, packing, secrets, toxicity
from strandlake.llm.queries import tokenizer_file

#: Documents with a toxicity score of at least this are rejected.
TOXIC = 0.7


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that score below TOXIC. The model learns from the documents and labels of sf_dir."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(F.col("text"), model, spark) < TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates (five-word shingles, similarity 0.8): that of the least doc_id.

    Of rows that repeat this doc_id, one stays; rows without a doc_id stay.
    """
    found = common.staged(near_dedup.near_duplicate_classes(docs, words=5, percent=80), "classes")
    gone = found.where("not kept").select("doc_id").distinct()
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = common.without(docs, gone.union(repeated).distinct())
    return once.unionByName(common.among(docs, repeated).dropDuplicates(["doc_id"]))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that leak no benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked in text, and n_chars to match."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of docs with their place in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_file(), keep_ids=False)


STAGES = [
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_filter),
    ("secret_scan", secret_masks),
    ("best_fit_packing", packed),
]

#: Trained scores, hashed signatures and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.staged(docs, name)
    return docs
