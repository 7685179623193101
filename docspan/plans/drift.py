"""Signature and drift queries over ready-made entry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspan.functions import text as X
from docspan.operators import drift as D
from docspan.operators import signatures as S
from docspan.plans.inputs import fixture, sql_input

FILES_SQL = "SELECT DISTINCT p_partkey % 97 AS file_id FROM part"
SNAPSHOT_SQL = "SELECT path, snapshot_sha FROM fx_bindings WHERE snapshot_sha IS NOT NULL"
STAGED_SQL = "SELECT path, CASE WHEN content_ok THEN 'text' ELSE '' END AS content, concat('h', cast(file_id AS string)) AS signature_hash FROM fx_bindings WHERE old_ok"
DOCS_SQL = "SELECT DISTINCT (p_partkey % 97) % 20 AS doc_id FROM part"
PLAN_DOCS_SQL = """
SELECT d.doc_id, count(b.file_id) AS bindings, CASE WHEN d.doc_id % 2 = 0 THEN 'generated' ELSE NULL END AS generated_text
FROM (SELECT DISTINCT p_partkey % 25 AS doc_id FROM part) d LEFT JOIN fx_bindings b ON b.doc_id = d.doc_id GROUP BY d.doc_id"""


def _hashed(spark, sf):
    """Bindings with the hash stored when they were made."""
    files = sql_input(spark, sf, FILES_SQL)
    stored = S.signature_hash(fixture(spark, sf, "fx_entries_old"), files)
    b = fixture(spark, sf, "fx_bindings").join(stored, "file_id", "left")
    return b.withColumn("signature_hash", F.when(F.col("has_stored_hash"), F.col("signature_hash")))


def _drift(spark, sf):
    return D.drift_files(_hashed(spark, sf), fixture(spark, sf, "fx_entries_old"), fixture(spark, sf, "fx_entries_new"))


def _worst(spark, sf):
    return D.worst_drift(sql_input(spark, sf, DOCS_SQL), _drift(spark, sf))


def signature_hashes(spark, sf):
    return S.signature_hash(fixture(spark, sf, "fx_entries_new"), sql_input(spark, sf, FILES_SQL))


def signature_changes(spark, sf):
    return S.diff_signatures(fixture(spark, sf, "fx_entries_old"), fixture(spark, sf, "fx_entries_new")).select(
        "file_id", F.array_join("changed_functions", ",").alias("changed_functions"))


def binding_current_sha(spark, sf):
    b = fixture(spark, sf, "fx_bindings").select("doc_id", "path", "commit_sha")
    return D.bind_current(b, sql_input(spark, sf, SNAPSHOT_SQL), ["path"]).select("doc_id", "path", "commit_sha", "current_sha")


def binding_hashes(spark, sf):
    b = fixture(spark, sf, "fx_bindings").select("doc_id", "path")
    return S.attach_hashes(b, sql_input(spark, sf, STAGED_SQL)).select("doc_id", "path", F.coalesce("signature_hash", F.lit("—")).alias("signature_hash"))


def drift_by_file(spark, sf):
    return _drift(spark, sf).withColumn("changed_functions", F.array_join("changed_functions", ","))


def drift_by_document(spark, sf):
    return _worst(spark, sf).select("*", X.drift_headline(F.col("worst_state")).alias("headline"), X.drift_tone(F.col("worst_state")).alias("tone"))


def rebound_bindings(spark, sf):
    new = S.signature_hash(fixture(spark, sf, "fx_entries_new"), sql_input(spark, sf, FILES_SQL))
    return D.rebind(_hashed(spark, sf), new).select("doc_id", "file_id", "path", "commit_sha", F.coalesce("signature_hash", F.lit("—")).alias("signature_hash"))


def regeneration_plan(spark, sf):
    return D.regeneration_plan(_worst(spark, sf), sql_input(spark, sf, PLAN_DOCS_SQL))


QUERIES = {
    "signature_hashes": signature_hashes,
    "signature_changes": signature_changes,
    "binding_current_sha": binding_current_sha,
    "binding_hashes": binding_hashes,
    "drift_by_file": drift_by_file,
    "drift_by_document": drift_by_document,
    "rebound_bindings": rebound_bindings,
    "regeneration_plan": regeneration_plan,
}


def _hash_sql(entries: str) -> str:
    return f"""SELECT f.file_id, sha256(coalesce(string_agg(e.sig, '|' ORDER BY e.sig), '')) AS signature_hash
FROM ({FILES_SQL}) f LEFT JOIN {entries} e ON e.file_id = f.file_id GROUP BY f.file_id"""


_CHANGES = """
SELECT file_id, string_agg(label, ',' ORDER BY label) AS changed_functions FROM (
  SELECT coalesce(o.file_id, n.file_id) AS file_id, concat(coalesce(o.name, n.name),
    CASE WHEN n.name IS NULL THEN ' (removed)' WHEN o.name IS NULL THEN ' (added)' ELSE ' (signature changed)' END) AS label
  FROM fx_entries_old o FULL JOIN fx_entries_new n ON n.file_id = o.file_id AND n.name = o.name
  WHERE o.name IS NULL OR n.name IS NULL OR o.sig <> n.sig) GROUP BY file_id"""
_STATES = f"""
WITH stored AS ({_hash_sql('fx_entries_old')}), fresh AS ({_hash_sql('fx_entries_new')}), changes AS ({_CHANGES}),
b AS (SELECT b.*, CASE WHEN has_stored_hash THEN s.signature_hash END AS signature_hash, f.signature_hash AS new_hash, c.changed_functions AS names
  FROM fx_bindings b JOIN stored s ON s.file_id = b.file_id JOIN fresh f ON f.file_id = b.file_id LEFT JOIN changes c ON c.file_id = b.file_id),
judged AS (
  SELECT *, CASE
    WHEN NOT content_requested THEN 'i' WHEN NOT content_ok THEN 'u'
    WHEN has_stored_hash AND new_hash = signature_hash THEN 'i'
    WHEN old_ok AND names IS NOT NULL THEN 's' WHEN old_ok THEN 'i'
    WHEN has_stored_hash THEN 'd' ELSE 'i' END AS j
  FROM b WHERE coalesce(snapshot_sha, commit_sha) <> commit_sha),
files AS (
  SELECT doc_id, path, commit_sha AS old_sha, snapshot_sha AS new_sha, CASE WHEN j = 'i' THEN 'implementation_changed' ELSE 'signature_changed' END AS drift_state,
    CASE j WHEN 'i' THEN '' WHEN 'u' THEN '{D.CONTENT_UNAVAILABLE}' WHEN 'd' THEN '{D.DETAILS_UNAVAILABLE}' ELSE names END AS changed_functions FROM judged),
docs AS (
  SELECT d.doc_id, CASE WHEN bool_or(f.drift_state = 'signature_changed') THEN 'signature_changed' WHEN count(f.path) > 0 THEN 'implementation_changed' ELSE 'current' END AS worst_state,
    count(f.path) > 0 AS is_outdated, count(f.path) AS changed_files FROM ({DOCS_SQL}) d LEFT JOIN files f ON f.doc_id = d.doc_id GROUP BY d.doc_id)
"""
_LABELS = "CASE worst_state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.DRIFT_HEADLINES.items()) + " END AS headline, CASE worst_state " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in X.DRIFT_TONES.items()) + " END AS tone"
ORACLES = {
    "signature_hashes": _hash_sql("fx_entries_new"),
    "signature_changes": _CHANGES,
    "binding_current_sha": "SELECT doc_id, path, commit_sha, coalesce(snapshot_sha, commit_sha) AS current_sha FROM fx_bindings",
    "binding_hashes": "SELECT doc_id, path, CASE WHEN old_ok AND content_ok THEN concat('h', file_id) ELSE '—' END AS signature_hash FROM fx_bindings",
    "drift_by_file": _STATES + "SELECT * FROM files",
    "drift_by_document": _STATES + f"SELECT *, {_LABELS} FROM docs",
    "rebound_bindings": _STATES + """
SELECT doc_id, file_id, path, coalesce(snapshot_sha, commit_sha) AS commit_sha,
  coalesce(CASE WHEN content_ok THEN new_hash ELSE signature_hash END, '—') AS signature_hash FROM b""",
    "regeneration_plan": _STATES + f"""
SELECT p.doc_id, CASE WHEN bindings = 0 THEN 'rejected' ELSE 'regenerate' END AS action,
  CASE WHEN bindings = 0 THEN 'This document has no bound source files to regenerate from.'
    WHEN generated_text IS NOT NULL THEN 'Regenerated from updated source (AI-enhanced)' ELSE 'Regenerated from updated source' END AS message
FROM ({PLAN_DOCS_SQL}) p LEFT JOIN docs d ON d.doc_id = p.doc_id WHERE bindings = 0 OR worst_state <> 'current'""",
}
