"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.llm import byte_bpe, fingerprints, language, licences, packing, quality, quality_rules, secret_scan, sentence_pieces, simhash, spelling, sql, token_store, whitening
from docspan.operators.storage import new_path

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), digest=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_tokens(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), path)
    return token_store.read_tokens(spark, path, digest=True)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir))
    places = F.array_join(F.transform("sentences", lambda x: x["at"].cast("string")), " ")
    return found.select("doc_id", "licence", F.array_join("licences", " ").alias("licences"), "sequence", places.alias("places"), "n_unknown")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel"
    )


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_byte_bpe, op3_quality_classifier, op4_token_store, op5_licence_scan, op6_language_id, op7_fingerprints, op8_quality_rules,
    op9_simhash, op10_secret_scan, op11_sentence_pieces, op12_spelling_groups, op13_whitening,
)}
#: The others hash, train or use a tokenizer; tests hold them against brute-force versions and held-out rows.
ORACLES = {"op5_licence_scan": sql.licence_scan_sql(), "op8_quality_rules": sql.quality_rules_sql(), "op12_spelling_groups": sql.spelling_groups_sql()}
