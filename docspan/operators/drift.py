"""Three-state drift of documents from their bound sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.operators.code import SIGNATURE_CLASS_FIELDS, SIGNATURE_FACTS, SIGNATURE_FIELDS, SIGNATURE_INTERFACE_FIELDS, code_facts, quarantine, with_signatures
from docspan.operators.signatures import change_label, compare_names, diff_signatures, signature_hash

# States in order of severity and the texts that stand in for unknown differences.
STATES = ["current", "implementation_changed", "signature_changed"]
CONTENT_UNAVAILABLE = "(content unavailable — check network/token)"
DETAILS_UNAVAILABLE = "(signature details unavailable)"


def bind_current(bindings: DataFrame, snapshot: DataFrame, on: list[str]) -> DataFrame:
    """Current SHA per binding; sources missing from the snapshot keep the bound one."""
    return bindings.join(snapshot, on, "left").withColumn("current_sha", F.coalesce(F.col("snapshot_sha"), F.col("commit_sha")))


def drift_state(requested: Column, content_ok: Column, old_ok: Column, stored_hash: Column, new_hash: Column, changes: Column) -> Column:
    """STRUCT<drift_state, changed_functions> of a binding whose SHA has changed.

    A signature change needs evidence: unreadable new content, a named difference, or a stored hash that
    differs while the old content cannot be read."""
    none = F.array().cast("array<string>")

    def outcome(state: str, names: Column) -> Column:
        return F.struct(F.lit(state).alias("drift_state"), names.alias("changed_functions"))

    stored = F.coalesce(stored_hash, F.lit("")) != ""
    mismatch = stored & (new_hash != stored_hash)
    same = outcome("implementation_changed", none)
    return (
        F.when(~requested, same)
        .when(~content_ok, outcome("signature_changed", F.array(F.lit(CONTENT_UNAVAILABLE))))
        .when(stored & ~mismatch, same)
        .when(old_ok & (F.size(F.coalesce(changes, none)) > 0), outcome("signature_changed", changes))
        .when(old_ok, same)
        .when(mismatch, outcome("signature_changed", F.array(F.lit(DETAILS_UNAVAILABLE))))
        .otherwise(same)
    )


def drift_files(bindings: DataFrame, old_entries: DataFrame, new_entries: DataFrame) -> DataFrame:
    """One row per changed binding. The cheap SHA comparison comes first; signatures are only read for the
    files that are left."""
    changed = bindings.withColumn("current_sha", F.coalesce("snapshot_sha", "commit_sha")).filter("current_sha <> commit_sha")
    files = changed.select("file_id").distinct()
    old = old_entries.join(files, "file_id", "left_semi")
    new = new_entries.join(files, "file_id", "left_semi")
    new_hash = signature_hash(new, files).withColumnRenamed("signature_hash", "new_hash")
    state = drift_state(F.col("content_requested"), F.col("content_ok"), F.col("old_ok"), F.col("signature_hash"),
                        F.col("new_hash"), F.col("changed_functions"))
    return (changed.join(new_hash, "file_id", "left").join(diff_signatures(old, new), "file_id", "left")
            .withColumn("d", state)
            .select("doc_id", "path", F.col("commit_sha").alias("old_sha"), F.col("current_sha").alias("new_sha"),
                    "d.drift_state", "d.changed_functions"))


def content_drift(bindings: DataFrame, contents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Drift from texts: ``contents`` has the current and ``blobs`` the bound text of each file (file_id,
    file_name, content; NULL or absent if unavailable). A text whose brackets do not pair up counts as unavailable.
    Only files whose SHA moved are read for signatures, and each text is read once: its hash travels with its entries."""
    changed = bindings.withColumn("current_sha", F.coalesce("snapshot_sha", "commit_sha")).filter("current_sha <> commit_sha")

    def side(files: DataFrame, n: int) -> DataFrame:
        return files.filter("content IS NOT NULL").select(
            F.struct("file_id", F.lit(n).alias("side")).alias("file_id"), "file_name", "content", F.col("file_id").alias("_id"))

    texts = side(blobs, 0).unionByName(side(contents, 1)).join(changed.select(F.col("file_id").alias("_id")).distinct(), "_id", "left_semi")
    readable, _ = quarantine(texts)
    entries = with_signatures(code_facts(readable, SIGNATURE_FACTS, SIGNATURE_FIELDS, SIGNATURE_CLASS_FIELDS, SIGNATURE_INTERFACE_FIELDS)).select(
        "file_id.file_id", "file_id.side", F.when(F.col("file_id.side") == 1, F.col("signature_hash")).alias("new_hash"), F.posexplode_outer("entries").alias("pos", "e")
    ).select("file_id", "side", "new_hash", "pos", "e.name", "e.sig")
    per_name = compare_names(entries, F.max("new_hash").alias("new_hash"), F.max(F.col("side") == 0).alias("old_ok"), F.max(F.col("side") == 1).alias("content_ok"))
    per_file = per_name.groupBy("file_id").agg(
        F.array_sort(F.collect_list(change_label())).alias("changed_functions"), F.max("new_hash").alias("new_hash"),
        F.max("old_ok").alias("old_ok"), F.max("content_ok").alias("content_ok"))
    state = drift_state(F.col("content_requested"), F.coalesce("content_ok", F.lit(False)), F.coalesce("old_ok", F.lit(False)),
                        F.col("signature_hash"), F.col("new_hash"), F.col("changed_functions"))
    return changed.join(per_file, "file_id", "left").withColumn("d", state).select(
        "doc_id", "path", F.col("commit_sha").alias("old_sha"), F.col("current_sha").alias("new_sha"), "d.drift_state", "d.changed_functions")


def worst_drift(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Worst state per document; documents without changed files are current."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("drift_state"))
    worst = files.groupBy("doc_id").agg(F.max(rank).alias("rank"), F.count("*").alias("changed_files"))
    return docs.select("doc_id").join(worst, "doc_id", "left").select(
        "doc_id", F.element_at(F.array(*[F.lit(s) for s in STATES]), F.coalesce("rank", F.lit(1)).cast("int")).alias("worst_state"),
        (F.coalesce("rank", F.lit(1)) > 1).alias("is_outdated"), F.coalesce("changed_files", F.lit(0)).alias("changed_files"))


def rebind(bindings: DataFrame, hashes: DataFrame) -> DataFrame:
    """Bindings after a regeneration: the fresh SHA, and the fresh hash where the file could be read."""
    fresh = hashes.select("file_id", F.col("signature_hash").alias("_fresh"))
    return bindings.join(fresh, "file_id", "left").select(
        "doc_id", "file_id", "path", F.coalesce("snapshot_sha", "commit_sha").alias("commit_sha"),
        F.when(F.col("content_ok"), F.coalesce("_fresh", "signature_hash")).otherwise(F.col("signature_hash")).alias("signature_hash"))


def regeneration_plan(drift_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents to rebuild and the version message; documents without bindings are rejected. ``docs`` has
    doc_id, bindings (their number) and generated_text (NULL unless a generator produced one)."""
    plan = docs.join(drift_docs.select("doc_id", "worst_state"), "doc_id", "left")
    unbound = F.col("bindings") == 0
    message = (F.when(unbound, "This document has no bound source files to regenerate from.")
               .when(F.col("generated_text").isNotNull(), "Regenerated from updated source (AI-enhanced)")
               .otherwise("Regenerated from updated source"))
    return plan.filter(unbound | (F.coalesce("worst_state", F.lit("current")) != "current")).select(
        "doc_id", F.when(unbound, "rejected").otherwise("regenerate").alias("action"), message.alias("message"))
