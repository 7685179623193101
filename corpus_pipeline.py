"""From raw documents to packed token sequences: quality rules, language, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it gets and returns the columns of documents, the last one the
packed sequences. ``run`` writes what a stage returns as Parquet in the shared folder and gives the reread table to the next,
so a lost executor costs a part of one stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.llm import language, packing, quality_rules, secret_scan, simhash
from docspan.operators.storage import new_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages before packing have left an executor's JVM large, so a worker of it remembers less and cuts fewer texts at a time.
PACK_REMEMBERED_BYTES, PACK_SLICE_BYTES = 32 << 20, 1 << 20
#: Documents whose pooled language probability is lower are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that their host repeats too often. Copies of a text count once and
    a host's first document keeps its lines: near-duplicate removal, not this stage, chooses among copies."""
    judged = quality_rules.quality_rules(docs, carry=COLUMNS, copies_once=True, spare_first=True)
    return judged.filter("kept").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language with some certainty; a null lang gets the predicted one."""
    found = language.identify(docs, carry=COLUMNS)
    sure = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id."""
    return simhash.first_of_groups(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with their secrets masked."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of power-of-two lengths."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=PACK_REMEMBERED_BYTES, slice_bytes=PACK_SLICE_BYTES)


STAGES = [("quality rules", quality), ("language id", languages), ("simhash near-dedup", near_duplicates), ("secret scans", secrets), ("packing", pack)]
#: Hashing, a trained network and a tokenizer have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
