"""Markdown tokens, outlines and tables of a document table. No job here shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.functions.markdown import md_tokens as tokens_of
from docspan.functions.text import strip_inline
from docspan.operators.rows import with_position


def md_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, token_no and the token's columns."""
    return with_position(docs, ["doc_id"], tokens_of(F.col("content")), "t").select(
        "doc_id", (F.col("pos") + 1).alias("token_no"), "t.*")


def md_outline(tokens: DataFrame) -> DataFrame:
    return tokens.filter("type = 'heading'").select("doc_id", "token_no", "level", strip_inline(F.col("text")).alias("text"))


def md_tables(tokens: DataFrame) -> DataFrame:
    """One row per table cell."""
    rows = with_position(tokens.filter("type = 'table'"), ["doc_id", "token_no"], F.col("rows"), "cells").withColumnRenamed("pos", "row_no")
    cells = with_position(rows, ["doc_id", "token_no", "row_no"], F.col("cells"), "cell").withColumnRenamed("pos", "col_no")
    return cells.withColumn("cell", strip_inline(F.col("cell")))


def missing_units(units: DataFrame, tokens: DataFrame) -> DataFrame:
    """Expected names without a level-3 heading of that name; headings are reduced to distinct names first."""
    headed = tokens.filter("type = 'heading' AND level = 3").select("doc_id", F.regexp_extract(
        strip_inline(F.col("text")), r"\A([\w$.]+)", 1).alias("name")).distinct()
    return units.join(headed, ["doc_id", "name"], "left_anti")


def completeness(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Expected and documented units per document, and the warning when there are too few headings."""
    expected = units.groupBy("doc_id").agg(F.count("*").alias("unit_count"))
    counted = docs.select("doc_id", F.regexp_count(F.col("content"), F.lit(r"(?m)^###\s")).alias("documented_count"))
    short = F.col("documented_count") < F.col("unit_count")
    warning = F.concat(F.lit("> ⚠️ **Incomplete documentation:** "), F.col("documented_count"), F.lit(" of "), F.col("unit_count"),
                       F.lit(" functions were documented above. Check server logs for details."))
    return counted.join(expected, "doc_id").select("doc_id", "unit_count", "documented_count", F.when(short, warning).alias("warning"))
