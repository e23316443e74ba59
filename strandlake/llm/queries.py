"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontamination, language_id, near_dedup, oracles, packing, periodic_runs, prefix_trie, quality, secrets, substring_dedup, token_files, toxicity, transport_stream

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), keep_ids=False)


def op3_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select(
        "doc_id", (toxicity.remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_features(transport_stream.media_column(_table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_report(secrets.secret_spans(_table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeated_windows(_table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.remainder(4) == 2
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.conversation_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.with_shared_openings(turns, convs))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.scratch_dir(spark)}/strandlake/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), folder, tokenizer_file())
    return token_files.documents(spark, folder)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), periodic_runs.by_document))


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_quality_kneser_ney": op3_quality_kneser_ney,
        "op4_toxicity": op4_toxicity,
        "op5_transport_stream": op5_transport_stream,
        "op6_decontamination": op6_decontamination,
        "op7_secret_scan": op7_secret_scan,
        "op9_language_id": op9_language_id,
        "op10_perspective_rotation": op10_perspective_rotation,
        "op8_substring_dedup": op8_substring_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_token_files": op12_token_files,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
