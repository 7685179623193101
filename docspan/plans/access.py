"""Access, membership, validation and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspan.functions.text import author_name
from docspan.operators import access as A
from docspan.operators import validation as C
from docspan.plans.inputs import fixture, sql_input

USER = 7
DOCS_SQL = """
SELECT doc_id, project_id, title, doc_id % 11 AS user_id, 1000 + (doc_id * 7919) % 100003 AS updated_at FROM fx_documents"""
# three project ids have no project row
LISTED_SQL = "SELECT doc_id, doc_id % 28 AS project_id, title, 1000 + (doc_id * 7919) % 100003 AS updated_at FROM fx_documents"
MEMBERS_SQL = """
SELECT project_id, user_id, login, role FROM fx_members
UNION ALL SELECT (c_nationkey + 3) % 28, c_custkey, c_name, 'editor' FROM customer"""
REQUESTS_SQL = """
SELECT event_id, user_id, event_id % 1300 AS doc_id, event_type = 'purchase' AS owner_only FROM events"""
USERS_SQL = """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10 ELSE NULL END AS github_id,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('Dev', cast(c_custkey AS string)) END AS github_login,
  concat('u', cast((c_custkey * 7) % 1100 AS string), '@example.com') AS email, c_name AS full_name FROM customer"""
INVITES_SQL = """
SELECT o_custkey % 25 AS project_id, CASE o_orderkey % 3 WHEN 0 THEN concat('dEV', cast(o_custkey AS string))
  WHEN 1 THEN concat('U', cast(o_custkey % 1300 AS string), '@Example.com') ELSE concat('nobody', cast(o_orderkey AS string)) END AS identifier
FROM orders"""
REPOS_SQL = """
SELECT concat('org', cast(s_nationkey AS string), '/', replace(s_name, '#', '-')) AS full_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'main' ELSE 'develop' END AS default_branch FROM supplier"""
REFS_SQL = f"SELECT full_name AS repo_full_name, default_branch AS branch FROM ({REPOS_SQL}) r UNION ALL SELECT full_name, 'release' FROM ({REPOS_SQL}) r2 WHERE default_branch = 'main'"
BRANCH_REQUESTS_SQL = """
SELECT l_orderkey AS request_id, l_linenumber AS line_no, concat('org', cast(s_nationkey AS string), '/', replace(s_name, '#', '-')) AS repo_full_name,
  CASE l_linenumber % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'release' ELSE 'master' END AS branch
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""
CHANGES_SQL = """
SELECT o_custkey % 25 AS project_id, o_custkey AS user_id, concat('new', cast(o_custkey AS string)) AS login,
  CASE WHEN o_orderkey % 3 = 0 THEN 'add' ELSE 'remove' END AS action, year(o_orderdate) AS yr, o_orderkey AS seq
FROM orders"""
GONE_SQL = "SELECT n_nationkey AS project_id FROM nation WHERE n_regionkey < 3"
VERSIONS_SQL = "SELECT o_custkey AS doc_id FROM orders"
NOTES_SQL = "SELECT doc_id % 25 AS project_id FROM documents"
FILES_SQL = "SELECT p_partkey % 25 AS project_id FROM part"
DATED_SQL = "SELECT project_id, project_name, owner_id, 1000 + (project_id * 7919) % 1013 AS updated_at FROM fx_projects"
PROJECT_ROWS_SQL = """
SELECT p_partkey AS record_id, CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN repeat(p_name, 6) WHEN 2 THEN NULL ELSE p_name END AS project_name,
  CASE p_partkey % 5 WHEN 0 THEN repeat('d', 1001) WHEN 1 THEN concat(repeat('d', 1000), '  ') ELSE NULL END AS description FROM part"""
VERSION_ROWS_SQL = "SELECT o_orderkey AS record_id, CASE o_orderkey % 9 WHEN 0 THEN repeat('m', 281) WHEN 1 THEN concat(repeat('m', 279), '  ') WHEN 2 THEN NULL ELSE o_orderpriority END AS message FROM orders"
DOCUMENT_ROWS_SQL = "SELECT doc_id AS record_id, CASE doc_id % 3 WHEN 0 THEN title ELSE concat(' ', title, ' ') END AS title FROM fx_documents"
COMMIT_ROWS_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS record_id, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('b', l_returnflag) END AS branch,
  CASE l_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN repeat('c', 281) ELSE l_returnflag END AS message FROM lineitem"""
LEAVERS_SQL = "SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'BUILDING'"
STAGED_SQL = "SELECT p_type AS file_key, p_partkey AS seq, p_name AS name, p_size AS size FROM part"
SIGNUPS_SQL = """
SELECT c_custkey AS record_id, CASE WHEN c_custkey % 6 = 0 THEN ' x ' ELSE c_name END AS full_name,
  CASE c_custkey % 5 WHEN 0 THEN 'not an address' WHEN 1 THEN 'a..b@example.com' WHEN 2 THEN NULL ELSE concat('u', cast(c_custkey AS string), '@example.com') END AS email
FROM customer"""
RATINGS_SQL = """
SELECT event_id AS record_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(event_id % 8 AS int) END AS rating, CASE WHEN event_id % 9 = 0 THEN repeat('x', 501) ELSE props END AS comment FROM events"""
GENERATE_SQL = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '  ' ELSE props END AS notes, cast(event_id % 2 AS int) AS files FROM events"


def _roles(spark, sf):
    return A.effective_roles(fixture(spark, sf, "fx_projects"), sql_input(spark, sf, MEMBERS_SQL))


def effective_roles(spark, sf):
    return _roles(spark, sf)


def accessible_documents(spark, sf):
    return A.accessible_docs(sql_input(spark, sf, LISTED_SQL), fixture(spark, sf, "fx_projects"), _roles(spark, sf), USER)


def access_audit(spark, sf):
    return A.audit_access(sql_input(spark, sf, REQUESTS_SQL), sql_input(spark, sf, DOCS_SQL), _roles(spark, sf))


def identity_resolution(spark, sf):
    return A.resolve_identities(fixture(spark, sf, "fx_profiles"), sql_input(spark, sf, USERS_SQL)).select(
        "github_id", "login", F.coalesce(F.col("user_id").cast("string"), F.lit("—")).alias("user_id"), "action", F.coalesce("new_email", F.lit("—")).alias("new_email"))


def invite_resolution(spark, sf):
    return A.resolve_invites(sql_input(spark, sf, INVITES_SQL), sql_input(spark, sf, USERS_SQL))[0]


def invite_errors(spark, sf):
    return A.resolve_invites(sql_input(spark, sf, INVITES_SQL), sql_input(spark, sf, USERS_SQL))[1]


def branch_resolution(spark, sf):
    return A.resolve_branches(sql_input(spark, sf, BRANCH_REQUESTS_SQL), sql_input(spark, sf, REFS_SQL), sql_input(spark, sf, REPOS_SQL))


def membership_changes(spark, sf):
    changes = sql_input(spark, sf, CHANGES_SQL).withColumnRenamed("yr", "at")
    return A.apply_membership(fixture(spark, sf, "fx_members"), changes)


def project_summaries(spark, sf):
    members = sql_input(spark, sf, MEMBERS_SQL)
    return A.project_summary(sql_input(spark, sf, DATED_SQL), members, sql_input(spark, sf, DOCS_SQL), _roles(spark, sf))


def feedback_overall(spark, sf):
    return A.feedback_summary(fixture(spark, sf, "fx_feedback"))


def feedback_by_document(spark, sf):
    return A.feedback_summary(fixture(spark, sf, "fx_feedback"), ["doc_id"])


def cascade_impact(spark, sf):
    return A.delete_impact(*[sql_input(spark, sf, q) for q in (GONE_SQL, DOCS_SQL, VERSIONS_SQL, NOTES_SQL, FILES_SQL)])


def cascade_documents(spark, sf):
    return A.deleted_docs(sql_input(spark, sf, GONE_SQL), sql_input(spark, sf, DOCS_SQL))


def account_removal_plan(spark, sf):
    return A.account_removal(sql_input(spark, sf, LEAVERS_SQL), fixture(spark, sf, "fx_projects"), _roles(spark, sf))


def duplicate_emails(spark, sf):
    return A.key_violations(sql_input(spark, sf, USERS_SQL).withColumn("email", F.lower("email")), ["email"])


def duplicate_version_keys(spark, sf):
    return A.key_violations(sql_input(spark, sf, "SELECT o_custkey AS doc_id, year(o_orderdate) AS version_no FROM orders"), ["doc_id", "version_no"])


def title_search(spark, sf):
    return A.search_titles(fixture(spark, sf, "fx_documents").select("doc_id", "title"), "THE")


def staged_files(spark, sf):
    return A.stage(sql_input(spark, sf, STAGED_SQL), "file_key", ["seq"])


def author_names(spark, sf):
    return sql_input(spark, sf, USERS_SQL).select("user_id", author_name(F.col("github_login"), F.col("email"), F.col("full_name")).alias("author"))


def _bad(spark, sf, sql, rules):
    bad = C.validate(sql_input(spark, sf, sql), C.RULESETS[rules])[1]
    return bad.select("record_id", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ").alias("errors"))


def rejected_users(spark, sf):
    return _bad(spark, sf, SIGNUPS_SQL, "users")


def rejected_projects(spark, sf):
    return _bad(spark, sf, PROJECT_ROWS_SQL, "projects")


def rejected_versions(spark, sf):
    return _bad(spark, sf, VERSION_ROWS_SQL, "versions")


def rejected_documents(spark, sf):
    return _bad(spark, sf, DOCUMENT_ROWS_SQL, "documents")


def rejected_commits(spark, sf):
    return _bad(spark, sf, COMMIT_ROWS_SQL, "commits")


def rejected_feedback(spark, sf):
    return _bad(spark, sf, RATINGS_SQL, "feedback")


def accepted_feedback(spark, sf):
    return C.validate(sql_input(spark, sf, RATINGS_SQL), C.RULESETS["feedback"])[0].select("record_id", "rating")


def generation_requests(spark, sf):
    return C.generatable(sql_input(spark, sf, GENERATE_SQL)).select("event_id", "files")


def repository_tree(spark, sf):
    return A.tree_order(A.tree_index(fixture(spark, sf, "fx_repo_tree"))).withColumn("parent_path", F.coalesce("parent_path", F.lit("")))


QUERIES = {f.__name__: f for f in (
    effective_roles, accessible_documents, access_audit, identity_resolution, invite_resolution, invite_errors, branch_resolution,
    membership_changes, project_summaries, feedback_overall, feedback_by_document, cascade_impact, cascade_documents,
    account_removal_plan, duplicate_emails, duplicate_version_keys, title_search, staged_files, author_names, rejected_users,
    rejected_projects, rejected_versions, rejected_documents, rejected_commits,
    rejected_feedback, accepted_feedback, generation_requests, repository_tree)}

_ROLES = f"""
WITH m AS ({MEMBERS_SQL}), roles AS (
  SELECT project_id, user_id, CASE WHEN bool_or(src = 0) THEN 'owner' ELSE min(role) END AS role FROM (
    SELECT project_id, owner_id AS user_id, 'owner' AS role, 0 AS src FROM fx_projects UNION ALL SELECT project_id, user_id, role, 1 FROM m) GROUP BY ALL) """
_USERS = f"WITH users AS ({USERS_SQL}) "
_INVITES = _USERS + f""", asked AS (
  SELECT i.project_id, i.identifier, l.user_id AS lu, l.github_login AS ll, e.user_id AS eu, coalesce(e.github_login, e.email) AS el
  FROM ({INVITES_SQL}) i LEFT JOIN users l ON lower(l.github_login) = lower(i.identifier)
  LEFT JOIN (SELECT email, min(user_id) AS user_id, arg_min(coalesce(github_login, ''), user_id) AS gl FROM users GROUP BY email) k
    ON contains(i.identifier, '@') AND k.email = lower(i.identifier) LEFT JOIN users e ON e.user_id = k.user_id) """
ORACLES = {
    "effective_roles": _ROLES + "SELECT * FROM roles",
    "accessible_documents": _ROLES + f"""
SELECT d.doc_id, d.project_id, d.title, d.updated_at, coalesce(p.project_name, '—') AS project_name FROM ({LISTED_SQL}) d
LEFT JOIN fx_projects p ON p.project_id = d.project_id WHERE d.project_id IN (SELECT project_id FROM roles WHERE user_id = {USER})""",
    "access_audit": _ROLES + f"""
SELECT r.event_id, r.user_id, r.doc_id, r.owner_only, CASE WHEN d.doc_id IS NULL THEN 'not_found'
  WHEN r.owner_only AND o.role = 'owner' THEN 'ok' WHEN NOT r.owner_only AND (o.role IS NOT NULL OR d.user_id = r.user_id) THEN 'ok' ELSE 'forbidden' END AS outcome
FROM ({REQUESTS_SQL}) r LEFT JOIN ({DOCS_SQL}) d ON d.doc_id = r.doc_id LEFT JOIN roles o ON o.project_id = d.project_id AND o.user_id = r.user_id""",
    "identity_resolution": _USERS + """
SELECT p.github_id, p.login, coalesce(cast(coalesce(g.user_id, e.user_id) AS varchar), '—') AS user_id,
  CASE WHEN g.user_id IS NOT NULL THEN 'found-by-github-id' WHEN e.user_id IS NOT NULL THEN 'found-by-email' ELSE 'created' END AS action,
  CASE WHEN g.user_id IS NULL AND e.user_id IS NULL THEN lower(coalesce(p.email, concat(p.login, '@users.noreply.github.com'))) ELSE '—' END AS new_email
FROM fx_profiles p LEFT JOIN users g ON g.github_id = p.github_id
LEFT JOIN (SELECT lower(email) AS email, min(user_id) AS user_id FROM users GROUP BY lower(email)) e ON e.email = lower(p.email)""",
    "invite_resolution": _INVITES + "SELECT project_id, identifier, coalesce(lu, eu) AS user_id, CASE WHEN lu IS NOT NULL THEN ll ELSE el END AS login, 'editor' AS role FROM asked WHERE coalesce(lu, eu) IS NOT NULL",
    "invite_errors": _INVITES + "SELECT project_id, identifier, 'not_found' AS error FROM asked WHERE coalesce(lu, eu) IS NULL",
    "branch_resolution": f"""
SELECT q.request_id, q.line_no, q.repo_full_name, q.branch, CASE WHEN f.branch IS NOT NULL THEN q.branch ELSE r.default_branch END AS resolved_branch, f.branch IS NULL AS fell_back
FROM ({BRANCH_REQUESTS_SQL}) q LEFT JOIN ({REFS_SQL}) f ON f.repo_full_name = q.repo_full_name AND f.branch = q.branch LEFT JOIN ({REPOS_SQL}) r ON r.full_name = q.repo_full_name""",
    "membership_changes": f"""
WITH c AS ({CHANGES_SQL}), last AS (
  SELECT project_id, user_id, arg_max(action, yr * 100000000 + seq) AS action, arg_max(login, yr * 100000000 + seq) AS login, bool_or(action = 'add') AS ever_added FROM c GROUP BY ALL)
SELECT coalesce(m.project_id, l.project_id) AS project_id, coalesce(m.user_id, l.user_id) AS user_id,
  CASE WHEN l.action = 'add' THEN l.login ELSE m.login END AS login, CASE WHEN l.action = 'add' THEN 'editor' ELSE m.role END AS role
FROM fx_members m FULL JOIN last l ON l.project_id = m.project_id AND l.user_id = m.user_id
WHERE l.action IS NULL OR l.action = 'add' OR (m.role = 'owner' AND NOT l.ever_added)""",
    "project_summaries": _ROLES + f"""
SELECT r.user_id, p.project_id, p.project_name, (SELECT count(*) FROM ({DOCS_SQL}) d WHERE d.project_id = p.project_id) AS doc_count,
  (SELECT count(*) FROM m WHERE m.project_id = p.project_id) AS member_count, r.role, p.updated_at FROM roles r JOIN ({DATED_SQL}) p ON p.project_id = r.project_id""",
    "feedback_overall": "SELECT count(*) AS count, coalesce(round(avg(rating), 2), 0) AS average FROM fx_feedback",
    "feedback_by_document": "SELECT doc_id, count(*) AS count, coalesce(round(avg(rating), 2), 0) AS average FROM fx_feedback GROUP BY doc_id",
    "cascade_impact": f"""
SELECT g.project_id, (SELECT count(*) FROM ({DOCS_SQL}) d WHERE d.project_id = g.project_id) AS documents,
  (SELECT count(*) FROM ({DOCS_SQL}) d JOIN ({VERSIONS_SQL}) v ON v.doc_id = d.doc_id WHERE d.project_id = g.project_id) AS versions,
  (SELECT count(*) FROM ({NOTES_SQL}) n WHERE n.project_id = g.project_id) AS notes,
  (SELECT count(*) FROM ({FILES_SQL}) f WHERE f.project_id = g.project_id) AS source_files FROM ({GONE_SQL}) g""",
    "cascade_documents": f"SELECT d.project_id, d.doc_id FROM ({DOCS_SQL}) d JOIN ({GONE_SQL}) g ON g.project_id = d.project_id",
    "account_removal_plan": _ROLES + f"""
SELECT r.user_id, r.project_id, CASE WHEN p.owner_id = r.user_id THEN 'delete_project' ELSE 'remove_member' END AS action
FROM roles r JOIN fx_projects p ON p.project_id = r.project_id JOIN ({LEAVERS_SQL}) l ON l.user_id = r.user_id""",
    "duplicate_emails": _USERS + "SELECT lower(email) AS email, count(*) AS copies FROM users GROUP BY 1 HAVING count(*) > 1",
    "duplicate_version_keys": "SELECT o_custkey AS doc_id, year(o_orderdate) AS version_no, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1",
    "title_search": "SELECT doc_id, title FROM fx_documents WHERE contains(lower(title), 'the')",
    "staged_files": "SELECT p_type AS file_key, min(p_partkey) AS seq, arg_min(p_name, p_partkey) AS name, arg_min(p_size, p_partkey) AS size FROM part GROUP BY p_type",
    "author_names": _USERS + "SELECT user_id, coalesce(nullif(github_login, ''), nullif(email, ''), full_name) AS author FROM users",
    "rejected_users": f"""
SELECT record_id, concat_ws('; ', a, b) AS errors FROM (
  SELECT record_id, CASE WHEN length(trim(full_name)) < 2 THEN 'full_name: Enter your full name' WHEN length(trim(full_name)) > 120 THEN 'full_name: String must contain at most 120 character(s)' END AS a,
    CASE WHEN email IS NULL OR contains(email, '..') OR NOT regexp_full_match(email, '[A-Za-z0-9_.+-]+@([A-Za-z0-9-]+\\.)+[A-Za-z]+') THEN 'email: Enter a valid email address' END AS b
  FROM ({SIGNUPS_SQL})) WHERE a IS NOT NULL OR b IS NOT NULL""",
    "rejected_projects": f"""
SELECT record_id, concat_ws('; ', a, b) AS errors FROM (
  SELECT record_id, CASE WHEN length(trim(coalesce(project_name, ''))) < 1 THEN 'project_name: Project name is required' WHEN length(trim(project_name)) > 140 THEN 'project_name: String must contain at most 140 character(s)' END AS a,
    CASE WHEN length(trim(description)) > 1000 THEN 'description: String must contain at most 1000 character(s)' END AS b FROM ({PROJECT_ROWS_SQL})) WHERE a IS NOT NULL OR b IS NOT NULL""",
    "rejected_versions": f"SELECT record_id, 'message: String must contain at most 280 character(s)' AS errors FROM ({VERSION_ROWS_SQL}) WHERE length(message) > 280",
    "rejected_documents": rf"SELECT record_id, 'title: String must contain at most 200 character(s)' AS errors FROM ({DOCUMENT_ROWS_SQL}) WHERE length(regexp_replace(title, '^\s+|\s+$', '', 'g')) > 200",
    "rejected_commits": f"""
SELECT record_id, concat_ws('; ', a, b) AS errors FROM (
  SELECT record_id, CASE WHEN coalesce(length(branch), 0) < 1 THEN 'branch: String must contain at least 1 character(s)' END AS a,
    CASE WHEN coalesce(length(message), 0) < 1 THEN 'message: String must contain at least 1 character(s)' WHEN length(message) > 280 THEN 'message: String must contain at most 280 character(s)' END AS b
  FROM ({COMMIT_ROWS_SQL})) WHERE a IS NOT NULL OR b IS NOT NULL""",
    "rejected_feedback": f"""
SELECT record_id, concat_ws('; ', a, b) AS errors FROM (
  SELECT record_id, CASE WHEN rating IS NULL THEN 'rating: Required' WHEN rating < 1 THEN 'rating: Number must be greater than or equal to 1' WHEN rating > 5 THEN 'rating: Number must be less than or equal to 5' END AS a,
    CASE WHEN length(comment) > 500 THEN 'comment: String must contain at most 500 character(s)' END AS b FROM ({RATINGS_SQL})) WHERE a IS NOT NULL OR b IS NOT NULL""",
    "accepted_feedback": f"SELECT record_id, rating FROM ({RATINGS_SQL}) WHERE rating BETWEEN 1 AND 5 AND coalesce(length(comment), 0) <= 500",
    "generation_requests": f"SELECT event_id, files FROM ({GENERATE_SQL}) WHERE trim(coalesce(notes, '')) <> '' OR files > 0",
    "repository_tree": """
WITH RECURSIVE nodes AS (SELECT path, type, regexp_replace(path, '/?[^/]*$', '') AS up FROM fx_repo_tree),
chain AS (
  SELECT path, type, up, up AS at_dir, 0 AS depth FROM nodes
  UNION ALL
  SELECT c.path, c.type, c.up, regexp_replace(c.at_dir, '/?[^/]*$', ''), c.depth + 1 FROM chain c JOIN fx_repo_tree d ON d.path = c.at_dir AND d.type = 'dir')
SELECT path, type, CASE WHEN max(depth) > 0 THEN up ELSE '' END AS parent_path, max(depth) AS depth FROM chain GROUP BY path, type, up""",
}
