"""The dealt operators applied with production parameters to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, jaccard, licenses, merkle, packing, passages, quality, sharding, spelling, token_counts, token_files, warc
from .common import written


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.quality_rules(docs, quality.fit_limits(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(own)
    return chat.digests(written(chat.format_trees(chat.turn_chain(rows)), "formatted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_documents(spark, sf_dir)).drop("node")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.dataset_manifest(_documents(spark, sf_dir))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_token_files, op3_ngram_jaccard_join, op4_token_counts, op5_quality_rules, op6_chat_formatting, op7_best_fit_packing, op8_substring_dedup,
        op9_license_scans, op10_benchmark_decontamination, op11_merkle_manifest, op12_sharding, op13_spelling_variants,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_warc_derivatives": warc.SQL, "op11_merkle_manifest": merkle.SQL, "op12_sharding": sharding.SQL, "op13_spelling_variants": spelling.SQL}
