"""Scans: collections, source files, repository listings, trees and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspan.schemas import schema

# Fixed value: file names worth documenting.
DOCUMENTABLE = r"(?i)\.(jsx?|tsx?|mdx?)\z"


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A collection under its declared schema, so that only declared columns are read."""
    return spark.read.format(fmt).schema(schema(name)).load(path)


#: Column of a scan that holds the text of records that could not be read.
MALFORMED = "malformed_record"


def scan(spark: SparkSession, name: str, path: str, glob: str = "*", fmt: str = "json") -> DataFrame:
    """Records of a collection in text files (JSON lines or CSV) under a folder, under its declared schema, with the file's path,
    size and time of change. A record that does not fit has nulls and its text in ``malformed_record``; empty files have no
    records. Files and folders are chosen by name before any is opened."""
    columns = schema(name).add(MALFORMED, "string")
    read = spark.read.format(fmt).schema(columns).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
    files = read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"),
                        F.col("_metadata.file_modification_time").alias("file_changed_at"))


def file_type(name: Column) -> Column:
    """Text after the last dot; the whole name when there is none."""
    return F.element_at(F.split(name, r"\.", -1), -1)


def read_source_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per text file under a folder that has any text: Spark's listing leaves empty files out. Names and sizes alone
    are listed without reading a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("file_path"), name.alias("file_name"), file_type(name).alias("file_type"),
                        F.decode("content", "UTF-8").alias("content"), F.col("length").alias("file_size"))


def documentable(tree: DataFrame) -> DataFrame:
    return tree.filter((F.col("type") == "dir") | F.col("path").rlike(DOCUMENTABLE))


def list_repos(repos: DataFrame, search: str | None = None, page: int = 1, per_page: int = 30, signed_in: bool = True) -> DataFrame:
    """A page of repositories, newest first. Signed in, the search filters the page and ``has_more`` says the
    page was full before it; otherwise the search covers name and description and nothing is paged."""
    q = F.lit((search or "").lower())
    if not signed_in:
        hit = F.contains(F.lower("name"), q) | F.contains(F.lower(F.coalesce("description", F.lit(""))), q)
        return repos.filter(hit).withColumn("has_more", F.lit(False))
    newest = repos.orderBy(F.col("updated_at").desc(), "full_name").offset((page - 1) * per_page).limit(per_page)
    # the page is at most per_page rows, so counting it in a window costs nothing
    counted = newest.withColumn("has_more", F.count("*").over(Window.partitionBy()) == per_page)
    return counted.filter(F.contains(F.lower("full_name"), q))


def decoded(content: Column, encoding: Column) -> Column:
    """Base64 payloads as text, others as they are."""
    return F.when(encoding == "base64", F.decode(F.unbase64(F.regexp_replace(content, "\n", "")), "UTF-8")).otherwise(content)


def read_snapshot(raw: DataFrame) -> DataFrame:
    """Decoded contents of a snapshot or blob table: a projection, keys are unique in the input."""
    return raw.withColumn("content", decoded(F.col("content"), F.coalesce("encoding", F.lit("")))).drop("encoding")
