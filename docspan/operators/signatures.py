"""API signatures: per-file hashes, differences between two sets of entries, hashes for bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_of(sigs: Column) -> Column:
    """SHA-256 of the sorted signatures joined by a bar; no signatures hash the empty string."""
    return F.sha2(F.array_join(F.array_sort(sigs), "|"), 256)


def signature_hash(entries: DataFrame, files: DataFrame) -> DataFrame:
    """One hash per file. The digest needs all of a file's signatures in order; they come from one file's text,
    so the group is no larger than a row that was already read."""
    per_file = entries.groupBy("file_id").agg(F.collect_list("sig").alias("sigs"))
    return files.select("file_id").join(per_file, "file_id", "left").select(
        "file_id", hash_of(F.coalesce(F.col("sigs"), F.array().cast("array<string>"))).alias("signature_hash"))


def compare_names(entries: DataFrame, *more: Column) -> DataFrame:
    """(file_id, name, change) for every name of entries with ``side`` 0 (old) or 1 (new): change is removed,
    added, signature changed or NULL. The later of equal names counts."""
    named = F.col("name").isNotNull()

    def last(side: int) -> Column:
        return F.max_by("sig", F.when(F.col("side") == side, F.col("pos")))

    pairs = entries.groupBy("file_id", "name").agg(
        last(0).alias("old_sig"), last(1).alias("new_sig"),
        F.max((F.col("side") == 0) & named).alias("in_old"), F.max((F.col("side") == 1) & named).alias("in_new"), *more)
    change = (F.when(F.col("in_old") & ~F.col("in_new"), "removed").when(F.col("in_new") & ~F.col("in_old"), "added")
              .when(F.col("old_sig") != F.col("new_sig"), "signature changed"))
    return pairs.withColumn("change", change).drop("old_sig", "new_sig", "in_old", "in_new")


def change_label() -> Column:
    """NULL for names without a change, which ``collect_list`` leaves out."""
    return F.when(F.col("change").isNotNull(), F.concat(F.col("name"), F.lit(" ("), F.col("change"), F.lit(")")))


def diff_signatures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sorted list of changed names per file; files without changes have no row. Both sides go through one
    aggregation by (file, name) rather than two aggregations and a full join."""
    both = old.select("file_id", "name", F.lit(0).alias("side"), "pos", "sig").unionByName(
        new.select("file_id", "name", F.lit(1).alias("side"), "pos", "sig"))
    changed = compare_names(both).filter(F.col("change").isNotNull())
    return changed.groupBy("file_id").agg(F.array_sort(F.collect_list(change_label())).alias("changed_functions"))


def attach_hashes(bindings: DataFrame, hashes: DataFrame) -> DataFrame:
    """Signature hash of the staged file each binding points at; NULL if the file is missing or empty."""
    known = hashes.select(F.col("path").alias("_path"), F.when(F.col("content") != "", F.col("signature_hash")).alias("signature_hash"))
    return bindings.join(known, F.col("path") == F.col("_path"), "left").drop("_path")
