"""Version log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspan.operators import versions as V
from docspan.plans.inputs import fixture, sql_input

# A stored log: numbered saves with author and commit columns.
LOG_SQL = """
SELECT doc_id, version_no, event_id, saved_at AS created_at, source, content, message,
  CASE WHEN author_id = 0 THEN NULL ELSE concat('dev', cast(author_id AS string)) END AS author_login,
  CASE WHEN author_id % 2 = 1 THEN 'https://img.example/a' ELSE NULL END AS author_avatar_url,
  concat('c', cast(event_id AS string)) AS commit_hash,
  CASE WHEN event_id % 7 = 0 THEN concat('x', cast(event_id AS string)) ELSE NULL END AS external_commit_sha,
  CASE WHEN event_id % 7 = 0 THEN concat('https://repo.example/', cast(event_id AS string)) ELSE NULL END AS external_commit_url
FROM numbered"""
NUMBERED_SQL = """SELECT *, cast(row_number() OVER (PARTITION BY doc_id ORDER BY saved_at, event_id) AS int) AS version_no FROM fx_saves"""
WITH_LOG = f"WITH numbered AS ({NUMBERED_SQL}), log AS ({LOG_SQL}) "


def log(spark, sf):
    V.number_versions(fixture(spark, sf, "fx_saves")).createOrReplaceTempView("numbered")
    return spark.sql(LOG_SQL)


def version_numbers(spark, sf):
    return V.number_versions(fixture(spark, sf, "fx_saves")).select("doc_id", "event_id", "version_no", "source", "message")


def version_numbers_split(spark, sf):
    """The same numbers when every document counts as hot and is numbered slice by slice."""
    return V.number_versions(fixture(spark, sf, "fx_saves"), hot_rows=4).select("doc_id", "event_id", "version_no", "source", "message")


def current_documents(spark, sf):
    return V.current_docs(log(spark, sf))


def version_timeline(spark, sf):
    t = V.newest_first(V.timeline(log(spark, sf)))
    return t.select("doc_id", "version_no", "commit_hash", "source", F.coalesce("author.login", F.lit("—")).alias("author"),
                    F.coalesce("external_commit.sha", F.lit("—")).alias("external_sha"),
                    F.coalesce("previous_commit", F.lit("—")).alias("previous_commit"))


def default_version_pairs(spark, sf):
    return V.default_pairs(log(spark, sf))


def version_pair_lookup(spark, sf):
    asked = sql_input(spark, sf, PAIRS_SQL)
    return V.version_pairs(asked, log(spark, sf)).select(
        "doc_id", "from_version", "to_version", F.coalesce("from_content", F.lit("")).alias("from_content"),
        F.coalesce("to_content", F.lit("")).alias("to_content"), F.coalesce("error", F.lit("ok")).alias("outcome"))


def document_contributors(spark, sf):
    return V.contributors(log(spark, sf)).select("doc_id", "total", F.array_join("first_logins", ",").alias("first_logins"))


def rollback_append(spark, sf):
    return V.apply_rollbacks(log(spark, sf), sql_input(spark, sf, ROLLBACKS_SQL))[0]


def rollback_errors(spark, sf):
    return V.apply_rollbacks(log(spark, sf), sql_input(spark, sf, ROLLBACKS_SQL))[1]


def published_stamps(spark, sf):
    return V.stamp_published(log(spark, sf), sql_input(spark, sf, COMMITS_SQL)).select(
        "doc_id", "version_no", F.coalesce("external_commit_sha", F.lit("—")).alias("sha"), F.coalesce("external_commit_url", F.lit("—")).alias("url"))


def document_patches(spark, sf):
    docs = sql_input(spark, sf, PATCHED_SQL)
    return V.apply_patches(docs, sql_input(spark, sf, PATCHES_SQL), "doc_id", ["title", "status"], ("yr", "seq"))


def default_projects(spark, sf):
    return V.default_project(sql_input(spark, sf, USERS_SQL), sql_input(spark, sf, OWNED_SQL)).select(
        "user_id", F.coalesce(F.col("project_id").cast("string"), F.lit("—")).alias("project_id"), "project_name", "is_new")


def commit_chain(spark, sf):
    return V.chain(V.number_versions(fixture(spark, sf, "fx_saves")), SEGMENT)


def commit_chain_breaks(spark, sf):
    versions = V.number_versions(fixture(spark, sf, "fx_saves"))
    stored = versions.join(V.chain(versions, SEGMENT), ["doc_id", "version_no"]).withColumn(
        "content", F.when(F.col("event_id") % 10 == 0, F.lit("tampered")).otherwise(F.col("content")))
    return V.verify_chain(stored, SEGMENT)


PAIRS_SQL = """
SELECT o_custkey AS doc_id, cast(min(o_orderkey) % 4 AS int) AS from_version, cast(max(o_orderkey) % 9 AS int) AS to_version
FROM orders GROUP BY o_custkey"""
ROLLBACKS_SQL = """
SELECT o_custkey AS doc_id, cast(o_orderkey % 12 + 1 AS int) AS version_no, o_orderkey AS event_id, o_orderdate AS at
FROM orders"""
COMMITS_SQL = """
SELECT o_custkey AS doc_id, cast(count(*) AS int) AS version_no, concat('s', cast(o_custkey AS string)) AS sha,
  concat('https://repo.example/c/', cast(o_custkey AS string)) AS url FROM orders GROUP BY o_custkey"""
PATCHED_SQL = "SELECT c_custkey AS doc_id, c_name AS title, c_mktsegment AS status, 0 AS updated_at FROM customer"
PATCHES_SQL = """
SELECT o_custkey AS doc_id, o_orderkey AS seq, year(o_orderdate) AS yr,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('title ', cast(o_orderkey AS string)) ELSE NULL END AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE NULL END AS status FROM orders"""
USERS_SQL = "SELECT c_custkey AS user_id FROM customer"
OWNED_SQL = """
SELECT o_orderkey AS project_id, concat('Project ', cast(o_orderkey AS string)) AS project_name, o_custkey AS owner_id, o_orderdate AS created_at
FROM orders"""

_D = "sha256(concat(length(version_no::varchar), ':', version_no, length(content), ':', content, length(message), ':', message))"
# Documents of the fixture have some dozens of versions; a short segment takes them over all three levels.
SEGMENT = 4


def _folded(name: str, entries: str, restart: str) -> str:
    """Links of a log, each over the one before; a link for which ``restart`` holds begins anew."""
    return f"""
{name} AS (
  SELECT doc_id, n, sha256('>' || d) AS v FROM {entries} WHERE n = 0
  UNION ALL
  SELECT e.doc_id, e.n, sha256(CASE WHEN {restart} THEN '' ELSE p.v END || '>' || e.d) FROM {name} p JOIN {entries} e ON e.doc_id = p.doc_id AND e.n = p.n + 1)"""


def _ends(name: str, links: str) -> str:
    return f"{name} AS (SELECT doc_id, n // {SEGMENT} AS n, arg_max(v, n) AS d FROM {links} GROUP BY ALL)"


def _anchored(name: str, links: str, chain: str) -> str:
    return f"""
{name} AS (SELECT l.doc_id, l.n, CASE WHEN c.v IS NULL THEN l.v ELSE sha256(c.v || '>' || l.v) END AS v
  FROM {links} l LEFT JOIN {chain} c ON c.doc_id = l.doc_id AND c.n = l.n // {SEGMENT} - 1)"""


_CHAIN = f"""
WITH RECURSIVE numbered AS ({NUMBERED_SQL}),
digests AS (SELECT doc_id, version_no, version_no - 1 AS n, {_D} AS d, content, message, event_id FROM numbered),
{_folded("inner_links", "digests", f"e.n % {SEGMENT} = 0")},
{_ends("inner_ends", "inner_links")},
{_folded("middle_links", "inner_ends", f"e.n % {SEGMENT} = 0")},
{_ends("middle_ends", "middle_links")},
{_folded("outer_links", "middle_ends", "false")},
{_anchored("middle_chain", "middle_links", "outer_links")},
{_anchored("whole_chain", "inner_links", "middle_chain")},
links AS (SELECT doc_id, cast(n + 1 AS int) AS version_no, v AS commit_hash FROM whole_chain)
"""

QUERIES = {
    "version_numbers": version_numbers,
    "version_numbers_split": version_numbers_split,
    "current_documents": current_documents,
    "version_timeline": version_timeline,
    "default_version_pairs": default_version_pairs,
    "version_pair_lookup": version_pair_lookup,
    "document_contributors": document_contributors,
    "rollback_append": rollback_append,
    "rollback_errors": rollback_errors,
    "published_stamps": published_stamps,
    "document_patches": document_patches,
    "default_projects": default_projects,
    "commit_chain": commit_chain,
    "commit_chain_breaks": commit_chain_breaks,
}
_NUMBERS = "WITH numbered AS (" + NUMBERED_SQL + ") SELECT doc_id, event_id, version_no, source, message FROM numbered"
_ROLLBACK = WITH_LOG + f", asked AS (SELECT r.*, l.content, l.doc_id IS NOT NULL AS hit FROM ({ROLLBACKS_SQL}) r LEFT JOIN log l USING (doc_id, version_no)) "
ORACLES = {
    "version_numbers": _NUMBERS,
    "version_numbers_split": _NUMBERS,
    "current_documents": WITH_LOG + "SELECT doc_id, max(version_no) AS current_version, arg_max(content, version_no) AS content FROM log GROUP BY doc_id",
    "version_timeline": WITH_LOG + """
SELECT doc_id, version_no, commit_hash, source, coalesce(author_login, '—') AS author, coalesce(external_commit_sha, '—') AS external_sha,
  coalesce(lag(commit_hash) OVER (PARTITION BY doc_id ORDER BY version_no), '—') AS previous_commit FROM log""",
    "default_version_pairs": WITH_LOG + """
SELECT doc_id, min(version_no) AS from_version, max(version_no) AS to_version
FROM (SELECT doc_id, version_no, row_number() OVER (PARTITION BY doc_id ORDER BY version_no DESC) AS r FROM log) WHERE r <= 2 GROUP BY doc_id HAVING count(*) = 2""",
    "version_pair_lookup": WITH_LOG + f"""
SELECT p.doc_id, p.from_version, p.to_version, coalesce(a.content, '') AS from_content, coalesce(b.content, '') AS to_content,
  CASE WHEN p.from_version = 0 OR p.to_version = 0 THEN 'bad_request' WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome
FROM ({PAIRS_SQL}) p LEFT JOIN log a ON a.doc_id = p.doc_id AND a.version_no = p.from_version LEFT JOIN log b ON b.doc_id = p.doc_id AND b.version_no = p.to_version""",
    "document_contributors": WITH_LOG + """, firsts AS (
  SELECT doc_id, author_login, max(version_no) AS newest FROM log WHERE author_login IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY newest DESC) AS r FROM firsts)
SELECT doc_id, count(*) AS total, string_agg(author_login, ',' ORDER BY r) FILTER (WHERE r <= 5) AS first_logins FROM ranked GROUP BY doc_id""",
    "rollback_append": _ROLLBACK + """
SELECT a.doc_id, cast(m.n + row_number() OVER (PARTITION BY a.doc_id ORDER BY a.at, a.event_id) AS int) AS version_no, a.content,
  concat('Rolled back to v', a.version_no) AS message, 'rollback' AS source
FROM asked a JOIN (SELECT doc_id, count(*) AS n FROM log GROUP BY doc_id) m ON m.doc_id = a.doc_id WHERE a.hit""",
    "rollback_errors": _ROLLBACK + "SELECT doc_id, version_no, event_id, 'not_found' AS error FROM asked WHERE NOT hit",
    "published_stamps": WITH_LOG + f"""
SELECT l.doc_id, l.version_no, coalesce(c.sha, l.external_commit_sha, '—') AS sha, coalesce(c.url, l.external_commit_url, '—') AS url
FROM log l LEFT JOIN ({COMMITS_SQL}) c ON c.doc_id = l.doc_id AND c.version_no = l.version_no""",
    "document_patches": f"""
WITH p AS ({PATCHES_SQL}), last AS (
  SELECT doc_id, arg_max(title, yr * 100000000 + seq) FILTER (WHERE title IS NOT NULL) AS title,
    arg_max(status, yr * 100000000 + seq) FILTER (WHERE status IS NOT NULL) AS status, max(yr) AS yr FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.title, d.title) AS title, coalesce(l.status, d.status) AS status, coalesce(l.yr, 0) AS updated_at
FROM ({PATCHED_SQL}) d LEFT JOIN last l ON l.doc_id = d.doc_id""",
    "default_projects": f"""
WITH owned AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, project_id) AS r FROM ({OWNED_SQL}))
SELECT u.user_id, coalesce(cast(o.project_id AS varchar), '—') AS project_id, coalesce(o.project_name, 'My Documents') AS project_name, o.project_id IS NULL AS is_new
FROM ({USERS_SQL}) u LEFT JOIN owned o ON o.owner_id = u.user_id AND o.r = 1""",
    "commit_chain": _CHAIN + "SELECT doc_id, version_no, commit_hash FROM links",
    "commit_chain_breaks": _CHAIN + """,
touched AS (SELECT doc_id, min(version_no) AS first_broken FROM digests WHERE event_id % 10 = 0 GROUP BY doc_id)
SELECT t.doc_id, t.first_broken, count(*) AS broken FROM touched t JOIN links l ON l.doc_id = t.doc_id AND l.version_no >= t.first_broken GROUP BY ALL""",
}
