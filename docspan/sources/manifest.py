"""The documentation manifest: JSON entries, their upsert, and the Markdown export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.functions.text import author_name, document_path, http_date, short_commit, slug
from docspan.operators.rows import with_position
from docspan.schemas import MANIFEST_DDL

GENERATOR = "docspan"


def _is_array(text: Column) -> Column:
    return text.rlike(r"\A\s*\[")


def parse_manifest(json: Column) -> Column:
    """ARRAY of entries; anything that is not a JSON array has none."""
    return F.when(_is_array(json), F.from_json(json, MANIFEST_DDL, {"mode": "PERMISSIVE"}))


def flatten(manifests: DataFrame, column: str = "json") -> DataFrame:
    """One row per (doc_path, source); entries without sources keep one row with an empty source."""
    keep = [c for c in manifests.columns if c != column]
    entries = with_position(manifests, keep, parse_manifest(F.col(column)), "e").withColumnRenamed("pos", "entry_no").filter("e.doc_path IS NOT NULL")
    return entries.select(*keep, "entry_no", "e.doc_path", "e.generated_at", "e.generator", "e.author_login", "e.version",
                          F.explode_outer("e.sources").alias("s")).select("*", "s.*").drop("s")


def _line_entries(text: Column) -> Column:
    """ARRAY<STRUCT<line_no, line, e>>: an entry for every line that holds one, null ``e`` for a line that cannot be read."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    filled = F.filter(lines, lambda x: x["line"].rlike(r"\S"))
    # parsed as an array of one: a line that is cut off gives no entry
    return F.transform(filled, lambda x: F.struct(x["line_no"], x["line"], F.when(x["line"].rlike(r'"doc_path"\s*:\s*"'), F.get(
        F.from_json(F.concat(F.lit("["), x["line"], F.lit("]")), MANIFEST_DDL, {"mode": "PERMISSIVE"}), F.lit(0))).alias("e")))


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file_path and text of every file; the text says which form the file has."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str, lines: bool | None = None, glob: str = "*.*") -> DataFrame:
    """Entries of every file under ``path``, with its ``file_path``: a file that begins with a bracket is one JSON array, any other
    holds one entry a line, as ``write_manifest`` writes them. ``lines`` takes all files in that form."""
    as_lines = ~_is_array(F.col("text")) if lines is None else F.lit(lines)
    array = F.transform(parse_manifest(F.col("text")), lambda e, i: F.struct((i + 1).alias("line_no"), e.alias("e")))
    listed = F.transform(_line_entries(F.col("text")), lambda x: F.struct(x["line_no"], x["e"]))
    rows = with_position(_files(spark, path, glob), ["file_path"], F.when(as_lines, listed).otherwise(array), "x").filter("x.e.doc_path IS NOT NULL")
    return rows.select("file_path", (F.col("x.line_no") - 1).alias("entry_no"), "x.e.doc_path", "x.e.generated_at", "x.e.generator", "x.e.author_login",
                       "x.e.version", F.explode_outer("x.e.sources").alias("s")).select("*", "s.*").drop("s")


def manifest_errors(spark: SparkSession, path: str, glob: str = "*.*") -> DataFrame:
    """file_path, line_no and text of what cannot be read: lines without an entry, and whole files (line 0) that are a broken array."""
    files = _files(spark, path, glob)
    whole = F.array(F.struct(F.lit(0).alias("line_no"), F.col("text").alias("line")))
    bad_lines = F.transform(F.filter(_line_entries(F.col("text")), lambda x: x["e"]["doc_path"].isNull()), lambda x: F.struct(x["line_no"], x["line"]))
    none = F.array().cast("array<struct<line_no:int,line:string>>")
    broken = F.when(_is_array(F.col("text")), F.when(F.size(F.coalesce(parse_manifest(F.col("text")), F.array().cast(MANIFEST_DDL))) == 0, whole).otherwise(none)).otherwise(bad_lines)
    return with_position(files, ["file_path"], broken, "x").select("file_path", "x.line_no", F.col("x.line").alias("text"))


def manifest_entries(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Documents with their bindings as manifest rows. ``docs`` has doc_id, title, path_override, user_id,
    current_version, source_bindings and generated_at."""
    names = users.select("user_id", author_name(F.col("github_login"), F.col("email"), F.col("full_name")).alias("author_login"))
    first = F.get(F.col("source_bindings"), F.lit(0))["path"]
    return docs.join(names, "user_id", "left").select(
        document_path(F.col("path_override"), first, F.col("title")).alias("doc_path"), F.col("source_bindings").alias("sources"),
        "generated_at", F.lit(GENERATOR).alias("generator"), "author_login", F.col("current_version").alias("version"))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of the same path are replaced, the others keep their order, new ones come last. ``entry_no``
    carries the order in both inputs."""
    kept = old.join(new.select("doc_path"), "doc_path", "left_anti").withColumn("part", F.lit(0))
    return kept.unionByName(new.withColumn("part", F.lit(1)))


def write_manifest(entries: DataFrame, path: str) -> None:
    """JSON lines, one entry per line, ordered by part and entry number across the files."""
    entries.repartitionByRange("part", "entry_no").sortWithinPartitions("part", "entry_no").drop("part", "entry_no").write.mode("overwrite").json(path)


def export_index(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Title, file name, current version, short newest commit and date of every document."""
    newest = versions.groupBy("doc_id").agg(F.max_by("commit_hash", "version_no").alias("commit"))
    return docs.join(newest, "doc_id", "left").select(
        "doc_id", "title", F.concat(slug(F.col("title")), F.lit(".md")).alias("file_name"), F.col("current_version").alias("version"),
        short_commit(F.col("commit")).alias("commit"), http_date(F.col("updated_at")).alias("date"))


def export_markdown(docs: DataFrame, path: str) -> None:
    """One text file per document in a folder of its slug and id: slugs may collide, ids do not."""
    (docs.select(slug(F.col("title")).alias("slug"), "doc_id", F.col("content").alias("value"))
     .repartition("doc_id").write.mode("overwrite").partitionBy("slug", "doc_id").text(path))


def slug_collisions(docs: DataFrame) -> DataFrame:
    return docs.groupBy(slug(F.col("title")).alias("slug")).agg(F.count("*").alias("documents")).filter("documents > 1")
